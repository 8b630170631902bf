"""Event and catalogue streams. Functions take batch or streaming frames alike unless they start a
query; every one has a batch result to compare with."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cellselect.operators.catalog import insert_ignore

TERMINAL = ("done", "error")


def watermarked(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withWatermark(ts, delay) if df.isStreaming else df


# --- catalogue --------------------------------------------------------------------------------

def stream_ingest(source: DataFrame, target: str, checkpoint: str, key: str, order: list[str], buckets: int = 16):
    """Insert-only ingest, exactly once per id: each batch appends the ids the target lacks.

    Rows lie under run (the checkpoint's hash), batch number and id bucket. A repeated batch replaces
    its own rows and no others, a new run never touches an older one's, and a batch reads only the
    buckets that its ids fall into.
    """
    spark = source.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    stored = T.StructType([*source.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("run", T.StringType()),
                           T.StructField("batch", T.LongType())])

    def add(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("bucket", bucket)
        try:
            existing = spark.read.schema(stored).parquet(target)
        except AnalysisException:  # nothing written yet
            existing = spark.createDataFrame([], stored)
        touched = [r[0] for r in batch.select("bucket").distinct().collect()]
        older = existing.where(F.col("bucket").isin(touched) & ~((F.col("run") == run) & (F.col("batch") == number)))
        fresh = insert_ignore(batch, older.select(*batch.columns), key, order)
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/run={run}/batch={number}")

    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedupe(events: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """First row per id; in a stream the state of an id is kept for the watermark delay."""
    if events.isStreaming:
        return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def stream_cell_stats(samples: DataFrame) -> DataFrame:
    """Running count and mean coordinate per (level, cell): update mode."""
    return samples.groupBy("level", "cell").agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("centroid_lat"),
                                                F.avg("lng").alias("centroid_lng"))


# --- requests ---------------------------------------------------------------------------------

def request_stages(events: DataFrame, gap: str = "60 minutes", delay: str = "2 hours") -> DataFrame:
    """Stage seconds per request session; heartbeats are dropped, a session ends after ``gap``."""
    e = watermarked(events.where(F.col("event") != "heartbeat"), "ts", delay)

    micros = F.unix_micros("ts")

    def at(name: str) -> Column:
        return F.max(F.when(F.col("event") == name, micros))

    g = e.groupBy("request_id", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.min("ts").alias("started_at"),
        ((at("stage1_done") - at("stage1_start")) / 1e6).alias("stage1_seconds"),
        ((at("stage2_extract_done") - at("stage2_extract_start")) / 1e6).alias("extract_seconds"),
        ((at("stage2_pinpoint_done") - at("stage2_pinpoint_start")) / 1e6).alias("pinpoint_seconds"),
        ((at("stage2_geocode_done") - at("stage2_geocode_start")) / 1e6).alias("geocode_seconds"),
        ((F.max(micros) - F.min(micros)) / 1e6).alias("total_seconds"))
    return g.drop("w")


def throttle(events: DataFrame, gap: str = "1 second", delay: str = "1 hour") -> DataFrame:
    """At most one event per request and calendar slot of ``gap``: the last one. The rule is one event per
    slot, not a least distance: two events on either side of a slot's border both stay."""
    e = watermarked(events, "ts", delay)
    last = e.groupBy("request_id", F.window("ts", gap).alias("w")).agg(
        F.max_by(F.struct("event_id", "ts", "event"), F.struct("ts", "event_id")).alias("l"))
    return last.select("request_id", F.col("l.event_id").alias("event_id"), F.col("l.ts").alias("last_ts"), F.col("l.event").alias("event"))


def stalled(events: DataFrame, gap_seconds: int, total_seconds: int) -> DataFrame:
    """Batch twin: rows (request_id, after, reason) – ``gap`` before a late next event, ``silent`` after
    a last event that is not terminal, ``total`` (after = the moment the limit passed) for a request
    with an event past its time limit."""
    from pyspark.sql import Window
    w = Window.partitionBy("request_id").orderBy("ts", "event_id")
    nxt = F.lead("ts").over(w)
    e = events.withColumn("_next", nxt)
    wait = F.unix_micros("_next") - F.unix_micros("ts")
    reason = (F.when(F.col("event").isin(*TERMINAL), None).when(F.col("_next").isNull(), "silent")
              .when(wait > gap_seconds * 1_000_000, "gap"))
    gaps = e.select("request_id", F.col("ts").alias("after"), reason.alias("reason")).where(F.col("reason").isNotNull())
    total = events.groupBy("request_id").agg(F.max("ts").alias("after"), F.min("ts").alias("_first"))
    late = total.where(F.unix_micros("after") - F.unix_micros("_first") > total_seconds * 1_000_000)
    passed = F.timestamp_micros(F.unix_micros("_first") + total_seconds * 1_000_000)
    return gaps.unionByName(late.select("request_id", passed.alias("after"), F.lit("total").alias("reason")))


#: One open request in the state of its group: first and last event, and the watermark's millisecond past which it is silent.
_OPEN = np.dtype([("request", "i8"), ("first", "i8"), ("last", "i8"), ("terminal", "?"), ("told", "?"), ("due", "i8")])


def stalled_stream(events: DataFrame, gap_seconds: int, total_seconds: int, delay: str = "1 hour") -> DataFrame:
    """Streaming form with event-time timers. A request's state is its first and last event only; it is
    silent when the watermark passes the gap after the last event. Requests are dealt into ``keyed.GROUPS`` groups,
    each with one state and one timer at the earliest such moment, and a batch handles a group's requests at
    once. Events of a request are expected in time order from batch to batch. ``total`` is told once, in the
    batch of the first event past the limit, however busy the request stays."""
    from cellselect.streaming.keyed import dealt, micros, stamps
    schema = "request_id long, after timestamp, reason string"
    gap, limit = gap_seconds * 1_000_000, total_seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        known = np.frombuffer(state.get[0], _OPEN) if state.exists else np.zeros(0, _OPEN)
        rows: list[tuple[np.ndarray, np.ndarray, str]] = []
        fresh = known[:0]
        if not state.hasTimedOut:
            new = pd.concat(list(batches))
            ids, ts, done = new["request_id"].to_numpy(), micros(new["ts"]), new["event"].isin(TERMINAL).to_numpy()
            order = np.lexsort((new["event_id"].to_numpy(), ts, ids))
            ids, ts, done = ids[order], ts[order], done[order]
            start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            end = np.r_[start[1:], len(ids)] - 1
            fresh = np.zeros(len(start), _OPEN)
            fresh["request"], fresh["first"], fresh["last"], fresh["terminal"] = ids[start], ts[start], ts[start], True
            _, old, at = np.intersect1d(known["request"], fresh["request"], assume_unique=True, return_indices=True)
            fresh[at] = known[old]
            known = np.delete(known, old)
            each = np.repeat(np.arange(len(start)), end - start + 1)
            before, ended = np.r_[0, ts[:-1]], np.r_[True, done[:-1]]
            before[start], ended[start] = fresh["last"], fresh["terminal"]
            before = np.maximum(before, fresh["last"][each])
            late = (ts - before > gap) & ~ended
            rows.append((ids[late], before[late], "gap"))
            fresh["first"], fresh["last"] = np.minimum(fresh["first"], ts[start]), np.maximum(fresh["last"], ts[end])
            over = ~fresh["told"] & (fresh["last"] - fresh["first"] > limit)
            rows.append((fresh["request"][over], fresh["first"][over] + limit, "total"))
            fresh["told"] |= over
            fresh["terminal"] = done[end]
            fresh["due"] = np.maximum((fresh["last"] + gap) // 1000, now + 1000)
        over = known["due"] < now
        silent = known[over & ~known["terminal"]]
        rows.append((silent["request"], silent["last"], "silent"))
        held = np.concatenate([known[~over], fresh])
        if len(held):
            state.update((held.tobytes(),))
            state.setTimeoutTimestamp(max(int(held["due"].min()), now + 1))
        else:
            state.remove()
        told = np.concatenate([r[0] for r in rows])
        if len(told):
            yield pd.DataFrame({"request_id": [None] * len(told) if key[1] else told, "after": stamps(np.concatenate([r[1] for r in rows])),
                                "reason": np.repeat([r[2] for r in rows], [len(r[0]) for r in rows])})

    e = dealt(events).withWatermark("ts", delay)
    return e.groupBy("_group", "_none").applyInPandasWithState(step, schema, "requests binary", "append", GroupStateTimeout.EventTimeTimeout)


def stream_eval(results: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Evaluation per tumbling window: n, mean, shares within 25 and 200 km, approximate median."""
    r = watermarked(results, "ts", delay)
    d = F.col("distance_km")
    g = r.groupBy(F.window("ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_km"), F.avg((d < 25).cast("double")).alias("within_25km"),
        F.avg((d < 200).cast("double")).alias("within_200km"), F.percentile_approx(d, 0.5, 10_000).alias("median_km"))
    return g.select(F.col("w.start").alias("window_start"), "n", "mean_km", "within_25km", "within_200km", "median_km")
