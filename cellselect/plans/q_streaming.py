"""Streams run over the whole tables with available-now triggers; batch twins beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellselect.functions import geo
from cellselect.operators import cells as C
from cellselect.plans.registry import query
from cellselect.session import scratch_path
from cellselect.streaming import events as X
from cellselect.streaming import keyed as K


def plain(df):
    """Timestamps without zone, as the given tables hold them."""
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n, d in df.dtypes if d == "timestamp"})


def as_stream(t, df, name: str, batches: int = 4):
    """The frame written as it is partitioned, at least one file per batch, and read back in about
    ``batches`` micro-batches; files grow in number with the data."""
    path = scratch_path(t.spark, name)
    files = max(batches, df.rdd.getNumPartitions())
    df.repartition(files).write.parquet(path)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-files // batches)).parquet(path)


def by_slices(t, df, build, name: str, slices: int = 4):
    """The table arrives in time slices; the query resumes from its checkpoint after each one. A last
    far-away event (request -1) moves the watermark past everything, so that all windows close."""
    path, out, state = (scratch_path(t.spark, f"{name}{part}") for part in ("", "-out", "-state"))
    span = df.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.struct("*")).scalar()
    at = (F.unix_micros("ts") - F.unix_micros(span["a"])) / (F.unix_micros(span["b"]) - F.unix_micros(span["a"]) + 1)
    sliced = df.withColumn("slice", F.floor(at * slices))
    last = df.agg(F.lit(-1).cast("long").alias("request_id"), (F.max("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts"),
                  F.lit(-1).cast("long").alias("event_id"), F.lit("done").alias("event"), F.lit("{}").alias("data"))
    for part in [sliced.where(F.col("slice") == i).drop("slice") for i in range(slices)] + [last.select(*df.columns)]:
        part.write.mode("append").parquet(path)
        stream = build(t.spark.readStream.schema(df.schema).parquet(path))
        (stream.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True)
         .format("parquet").option("path", out).start().awaitTermination())
    return t.spark.read.schema(stream.schema).parquet(out).where("request_id >= 0")


def finish(t, stream, name: str, mode: str = "append"):
    """Run to the end of the input into Parquet files and read them."""
    out = scratch_path(t.spark, name)
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", scratch_path(t.spark, f"{name}-state"))
         .trigger(availableNow=True).format("parquet").option("path", out).start())
    q.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out)


def latest(t, stream, key: list[str], name: str):
    """Update-mode results: the last batch's row per key."""
    out = scratch_path(t.spark, name)

    def add(batch, number):
        batch.withColumn("_n", F.lit(number)).write.mode("overwrite").parquet(f"{out}/b={number}")

    stream.writeStream.outputMode("update").foreachBatch(add).option(
        "checkpointLocation", scratch_path(t.spark, f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    rows = t.spark.read.parquet(out).drop("b")
    rest = [c for c in stream.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_n").alias("l")).select(*key, "l.*")


@query("x1_stream_ingest", "SELECT count(*) AS n, count(DISTINCT pano_id) AS ids, cast(sum(sample_key) AS bigint) AS keys FROM samples", "samples")
def x1(t):
    """Every sample arrives twice; the target holds each id once."""
    s = t.samples.select("pano_id", "sample_key", "lat", "lng")
    src = as_stream(t, s.unionByName(s), "ingest")
    target = scratch_path(t.spark, "target")
    X.stream_ingest(src, target, scratch_path(t.spark, "ingest-state"), "pano_id", ["sample_key"]).awaitTermination()
    rows = t.spark.read.parquet(target)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pano_id").alias("ids"), F.sum("sample_key").alias("keys"))


@query("x2_stream_dedupe", "SELECT count(*) AS n, cast(sum(event_id) AS bigint) AS ids FROM progress", "progress")
def x2(t):
    e = t.progress.select("event_id", "ts")
    out = finish(t, X.stream_dedupe(as_stream(t, e.unionByName(e), "dedupe"), "event_id", "ts", "40 days"), "deduped")
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def _epoch(name):
    return f"max(CASE WHEN event = '{name}' THEN epoch_us(ts) END)"


_STAGES = f"""
WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY request_id ORDER BY ts) AS prev FROM progress WHERE event <> 'heartbeat'),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) >= 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY ts) AS session FROM e)
SELECT request_id, count(*) AS events, min(ts) AS started_at, round(({_epoch('stage1_done')} - {_epoch('stage1_start')}) / 1e6, 3) AS stage1_seconds,
       round(({_epoch('stage2_extract_done')} - {_epoch('stage2_extract_start')}) / 1e6, 3) AS extract_seconds,
       round(({_epoch('stage2_pinpoint_done')} - {_epoch('stage2_pinpoint_start')}) / 1e6, 3) AS pinpoint_seconds,
       round(({_epoch('stage2_geocode_done')} - {_epoch('stage2_geocode_start')}) / 1e6, 3) AS geocode_seconds, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 3) AS total_seconds
FROM s GROUP BY request_id, session"""
_STALLED = """
WITH e AS (SELECT *, lead(ts) OVER (PARTITION BY request_id ORDER BY ts, event_id) AS nxt FROM progress)
SELECT request_id, ts AS after, CASE WHEN nxt IS NULL THEN 'silent' ELSE 'gap' END AS reason FROM e
WHERE event NOT IN ('done', 'error') AND (nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) > 900000000)
UNION ALL SELECT request_id, min(ts) + INTERVAL 3000 SECOND, 'total' FROM progress GROUP BY request_id HAVING max(epoch_us(ts)) - min(epoch_us(ts)) > 3000000000"""
_THROTTLED = """
SELECT request_id, event_id, ts AS last_ts, event FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id, epoch_us(ts) // 600000000 ORDER BY ts DESC, event_id DESC) AS rn FROM progress) WHERE rn = 1"""


def _seconds(df):
    return plain(df).withColumns({c: F.round(c, 3) for c in ("stage1_seconds", "extract_seconds", "pinpoint_seconds", "geocode_seconds", "total_seconds")})


@query("x3_request_stages", _STAGES, "progress")
def x3(t):
    return _seconds(X.request_stages(t.progress, "10 minutes"))


@query("x3_request_stages_stream", _STAGES, "progress")
def x3_stream(t):
    return _seconds(by_slices(t, t.progress, lambda e: X.request_stages(e, "10 minutes"), "stages"))


@query("x4_stalled", _STALLED, "progress")
def x4(t):
    return plain(X.stalled(t.progress, 900, 3000))


@query("x4_stalled_stream", _STALLED, "progress")
def x4_stream(t):
    return plain(by_slices(t, t.progress, lambda e: X.stalled_stream(e, 900, 3000), "stalls"))


@query("x5_throttle", _THROTTLED, "progress")
def x5(t):
    return plain(X.throttle(t.progress, "10 minutes"))


@query("x5_throttle_stream", _THROTTLED, "progress")
def x5_stream(t):
    return plain(by_slices(t, t.progress, lambda e: X.throttle(e, "10 minutes"), "throttle"))


_SPACED = """
WITH e AS (SELECT request_id, event_id, ts, event, row_number() OVER (PARTITION BY request_id ORDER BY ts, event_id) AS pos FROM progress),
k AS (SELECT * FROM e WHERE pos = 1
      UNION ALL SELECT request_id, event_id, ts, event, pos FROM (SELECT e.*, row_number() OVER (PARTITION BY e.request_id ORDER BY e.pos) AS rn
                                 FROM k JOIN e ON e.request_id = k.request_id AND e.pos > k.pos AND epoch_us(e.ts) - epoch_us(k.ts) >= 700000000) WHERE rn = 1)
SELECT request_id, event_id, ts, event FROM k"""


@query("x5_least_gap", _SPACED, "progress")
def x5_gap(t):
    """No two events of a request closer than 700 seconds."""
    return plain(K.least_gap(t.progress, 700))


@query("x5_least_gap_stream", _SPACED, "progress")
def x5_gap_stream(t):
    return plain(by_slices(t, t.progress, lambda e: K.least_gap(e, 700), "spaced"))


@query("x4_stalled_keyed", _STALLED, "progress")
def x4_keyed(t):
    """The same on keyed state that takes a request's events in any order."""
    return plain(by_slices(t, t.progress, lambda e: K.stalled_keyed(e, 900, 3000), "keyed"))


_STATS = "SELECT level, cell, count(*) AS n, round(avg(lat), 6) AS centroid_lat, round(avg(lng), 6) AS centroid_lng FROM long_cells GROUP BY level, cell"


@query("x6_stream_cell_stats", _STATS, "long_cells")
def x6(t):
    rows = C.explode_levels(t.s2_samples, ["lat", "lng"])
    out = latest(t, X.stream_cell_stats(as_stream(t, rows, "cells")), ["level", "cell"], "cells-out")
    return out.select("level", geo.s2_text(F.col("cell")).alias("cell"), "n", *[F.round(c, 6).alias(c) for c in ("centroid_lat", "centroid_lng")])


@query("x7_stream_eval", """
SELECT date_trunc('day', ts) AS window_start, count(*) AS n, round(avg(value * 10), 6) AS mean_km,
       round(avg(CASE WHEN value * 10 < 25 THEN 1.0 ELSE 0.0 END), 6) AS within_25km, round(avg(CASE WHEN value * 10 < 200 THEN 1.0 ELSE 0.0 END), 6) AS within_200km,
       round(quantile_disc(value * 10, 0.5), 6) AS median_km FROM events GROUP BY 1""")
def x7(t):
    """The event value stands for a distance."""
    r = t.read("events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("value") * 10).alias("distance_km"))
    out = latest(t, X.stream_eval(as_stream(t, r, "eval"), delay="40 days"), ["window_start"], "eval-out")
    return plain(out).select("window_start", "n", *[F.round(c, 6).alias(c) for c in ("mean_km", "within_25km", "within_200km", "median_km")])
